"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A block is the text between two block-level tags. Its features are the tags, classes and ids above it, traits of its text, and how it
stands to the rest of the page: the length and links of its neighbours, and the share of the page's text that has its path. The field is trained by maximum likelihood on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlode.llm.common import slices

# Fixed values of HTML: elements that break the line, that have no end tag, whose text is never shown, and that end an open one.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style title template textarea iframe noembed noframes noscript".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

#: Where a tag's name ends, and what stands between it and the end of the tag: quoted strings and other characters.
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
INSIDE = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
ENDS = {tag: re.compile(rf"</{tag}\b", re.I) for tag in HIDDEN}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
NOTES = "cookie|subscribe|newsletter|copyright|©|all rights reserved|sign up|signup|log in|login|comment|reply|replies|share|advert|sponsor|related|privacy|terms of|click here|read more|follow us".split("|")


class Path:
    """The block-level elements above a text: the innermost one's tag, and features of them all. A page's blocks share their paths.

    known: the features that a model has; others are left out, so that no page makes a path of many."""

    __slots__ = ("features", "score", "tag")

    def __init__(self, tag: str, names: set[str], above: Path | None, known: Container[str] | None):
        self.tag, self.score = tag, None
        own = frozenset(f for f in (f"in:{tag}", *(f"name:{w}" for w in names)) if known is None or f in known)
        self.features = own if above is None else above.features if own <= above.features else above.features | own


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path | None, text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


class Page:
    """The rest of a page from a place on. Searches for the end of a comment, of a hidden element or of a quote that fail once fail at once from then on, so that a page takes time in proportion to its length."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def after(self, what: str, at: int) -> int:
        """Where the next what ends, the end of the page if there is none."""
        if what in self.missing or (found := self.page.find(what, at)) < 0:
            self.missing.add(what)
            return len(self.page)
        return found + len(what)

    def closed(self, tag: str, at: int) -> int:
        """Where the next end tag of a hidden element ends."""
        found = ENDS[tag].search(self.page, at) if tag not in self.missing else None
        if found is None:
            self.missing.add(tag)
            return len(self.page)
        return self.after(">", found.end())

    def tag(self, at: int) -> tuple[int, str, str] | None:
        """End, name and attributes of the tag whose name begins at a place. None if it never ends."""
        name = NAME.match(self.page, at)
        if name is None or ">" in self.missing:
            return None
        if self.page.find(">", name.end()) < 0:
            self.missing.add(">")
            return None
        inside = INSIDE.match(self.page, name.end()) if "quote" not in self.missing else None
        if inside is None:  # a quote that never ends: the tag ends at its first >
            self.missing.add("quote")
            end = self.page.find(">", name.end()) + 1
            return end, name[0].lower(), self.page[name.end() : end - 1]
        return inside.end(), name[0].lower(), self.page[name.end() : inside.end() - 1]



def blocks_of(text: str, known: Container[str] | None = None, paths: dict[tuple, Path] | None = None) -> list[Block]:
    """Leaf blocks in page order: their text with references decoded and white space as single spaces, the path of block-level elements above, the share of the text in links.

    An element that the standard lets a later one close is closed by it. Elements are counted by tag, so that an end tag without a
    beginning is known as such at once, and each element is pushed and popped once. paths: those of earlier pages, for reuse."""
    paths = {} if paths is None else paths
    out: list[Block] = []
    stack: list[tuple[str, Path | None]] = []  # tag, and the path from it upwards
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    total = linked = 0
    page = Page(text)

    def end() -> None:
        nonlocal total, linked
        if parts:
            raw = "".join(parts)
            if shown := " ".join((entities.unescape(raw) if "&" in raw else raw).split()):
                out.append(Block(stack[-1][1] if stack else None, shown, linked / max(1, total)))
            parts.clear()
        total = linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def add(shown: str) -> None:
        nonlocal total, linked
        parts.append(shown)
        total += len(shown)
        linked += len(shown) if open_tags["a"] else 0

    at, size = 0, len(text)
    while at < size:
        start = text.find("<", at)
        if start != at:
            add(text[at : start if start >= 0 else size])
            at = start if start >= 0 else size
            continue
        follows = text[at + 1 : at + 2]
        if text.startswith("<!--", at):
            at = page.after("-->", at + 4)
            continue
        ending = follows == "/"
        if (found := page.tag(at + 1 + ending)) is None:
            if follows in ("!", "?", "/"):
                at = page.after(">", at)
            else:
                add("<")
                at += 1
            continue
        at, tag, attributes = found
        if tag == "br":
            parts.append(" ")
        elif ending:
            if tag in BLOCK:
                end()
            if open_tags[tag]:
                while pop() != tag:
                    pass
        elif tag in HIDDEN:
            at = page.closed(tag, at)
        else:
            if tag in BLOCK:
                end()
                scope, ended = SCOPES.get(tag, ()), CLOSES.get(tag, ())
                # Inline elements and what ends here, down to the nearest block that stays open.
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in BLOCK and open_tags["p"]:
                    k -= 1
                if k >= 0 and stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                if any(open_tags[t] for t in ended):
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in ended and stack[k][0] not in scope:
                        k -= 1
                    while k >= 0 and stack[k][0] in ended:
                        while len(stack) > k:
                            pop()
                        k -= 1
            if tag not in VOID and not attributes.endswith("/"):
                above = stack[-1][1] if stack else None
                if tag in BLOCK:
                    key = (above, tag, attributes)
                    if (path := paths.get(key)) is None:
                        if len(paths) > 20_000:
                            paths.clear()
                        names = set(WORD.findall(" ".join("".join(x) for x in NAMES.findall(attributes)).lower())) if attributes else set()
                        path = paths[key] = Path(tag, names, above, known)
                    above = path
                stack.append((tag, above))
                open_tags[tag] += 1
    end()
    return out


def path_features(path: Path | None) -> list[str]:
    return [*path.features, f"own:{path.tag}"] if path else ["own:none"]


def shape(block: Block) -> tuple[int, int, bool, bool]:
    """Traits of a block's text: length, share of links, whether a sentence ends it, whether it says what only notes say."""
    text = block.text
    return min((text.count(" ") + 1).bit_length(), 7), int(block.linked * 3.99), text[-1] in ".!?…", any(map(text.lower().__contains__, NOTES))


def shape_features(own: tuple[int, int, bool, bool]) -> list[str]:
    words, linked, stop, note = own
    return [f"words:{words}", f"linked:{linked}", f"stop:{stop}", f"note:{note}:{words}", "bias"]


def text_features(block: Block) -> list[str]:
    return shape_features(shape(block))


def near_features(before: tuple | None, after: tuple | None, part: int) -> list[str]:
    """The length and links of the blocks before and after, if any, and the level of shares()."""
    return [f"{side}:{other[0]}:{other[1]}" if other else f"{side}:none" for side, other in (("before", before), ("after", after))] + [f"part:{part}"]


def shares(blocks: list[Block]) -> list[int]:
    """For each block the level (0 to 4) of the share that the blocks of its path have in the page's text outside links."""
    sizes: dict[int, float] = {}
    for b in blocks:
        sizes[id(b.path)] = sizes.get(id(b.path), 0) + len(b.text) * (1 - b.linked)
    whole = max(1, sum(sizes.values()))
    levels = {path: (size >= 0.02 * whole) + (size >= 0.06 * whole) + (size >= 0.2 * whole) + (size >= 0.5 * whole) for path, size in sizes.items()}
    return [levels[id(b.path)] for b in blocks]


def page_features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block."""
    shapes, parts = [shape(b) for b in blocks], shares(blocks)
    return [[*path_features(b.path), *shape_features(own), *near_features(before, after, part)] for b, own, before, after, part in zip(blocks, shapes, [None, *shapes], [*shapes[1:], None], parts, strict=False)]


class Field:
    """Weights of features for the label 1 (main text) over 0, and of transitions."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.moves = np.zeros((2, 2))
        self.paths: dict[tuple, Path] = {}
        self.shapes: dict[tuple, float] = {}
        self.nears: dict[tuple, float] = {}

    def value(self, features: list[str]) -> float:
        return float(sum(self.weights[self.numbers[f]] for f in sorted(features) if f in self.numbers))

    def scores(self, blocks: list[Block]) -> list[float]:
        """Sums of the weights of page_features(); those of the few shapes and surroundings are kept."""
        shapes, out = [shape(b) for b in blocks], []
        for b, own, before, after, part in zip(blocks, shapes, [None, *shapes], [*shapes[1:], None], shares(blocks), strict=False):
            if b.path is None:
                above = self.value(path_features(None))
            elif (above := b.path.score) is None:
                above = b.path.score = self.value(path_features(b.path))
            if (text := self.shapes.get(own)) is None:
                text = self.shapes[own] = self.value(shape_features(own))
            around = (before and before[:2], after and after[:2], part)
            if (near := self.nears.get(around)) is None:
                near = self.nears[around] = self.value(near_features(*around))
            out.append(above + text + near)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        scores = self.scores(blocks)
        zero, one, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0 = (zero + stay0 >= one + to0, zero + to1 >= one + stay1)
            zero, one = max(zero + stay0, one + to0), max(zero + to1, one + stay1) + s
            back.append(from0)
        labels = [int(one > zero)]
        for came0, came1 in reversed(back):
            labels.append(0 if (came1 if labels[-1] else came0) else 1)
        return labels[::-1]

    def slope(self, features: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of a page's labels, and its derivatives by the weights and by the transitions: forward and backward sums."""
        s = np.array([self.weights[f].sum() for f in features])
        e = np.stack([np.zeros(len(s)), s], axis=1)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, len(e)):
            a[t] = e[t] + np.logaddexp(a[t - 1, 0] + self.moves[0], a[t - 1, 1] + self.moves[1])
        for t in range(len(e) - 2, -1, -1):
            x = self.moves + (e[t + 1] + b[t + 1])[None, :]
            b[t] = np.logaddexp(x[:, 0], x[:, 1])
        z = np.logaddexp(*a[-1])
        p = np.exp(a + b - z)[:, 1]
        g, gm = np.zeros(len(self.weights)), np.zeros((2, 2))
        for f, d in zip(features, labels - p, strict=True):
            np.add.at(g, f, d)
        for t in range(1, len(e)):
            gm[labels[t - 1], labels[t]] += 1
            gm -= np.exp(a[t - 1][:, None] + self.moves + (e[t] + b[t])[None, :] - z)
        return float(s @ labels + self.moves[labels[:-1], labels[1:]].sum() - z), g, gm

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 25, rate: float = 0.5, decay: float = 1e-4, seed: int = 6) -> None:
        """Adagrad on the log likelihood of the label sequences, by forward and backward sums."""
        rows = []
        for blocks, labels in pages:
            rows.append(([np.array([self.numbers.setdefault(f, len(self.numbers)) for f in own]) for own in page_features(blocks)], np.array(labels)))
        self.weights = np.zeros(len(self.numbers))
        seen, seen_moves = np.full(len(self.weights), 1e-2), np.full((2, 2), 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                features, labels = rows[i]
                if not features:
                    continue
                _, g, gm = self.slope(features, labels)
                g -= decay * self.weights
                seen += g * g
                self.weights += rate * g / np.sqrt(seen)
                seen_moves += gm * gm
                self.moves += 0.3 * rate * gm / np.sqrt(seen_moves)


def labelled_pages(n: int = 500, seed: int = 9) -> list[tuple[list[Block], list[int]]]:
    """Training pages: layouts drawn from the parts that web pages are made of, each part's blocks labelled by its kind.

    On a third of the pages the names of text, menus and footers say nothing, so that the field learns to go by tags, text and
    surroundings where it knows no name; there the text may also stand in bare `div` or in a cell of a layout table."""
    rng, plain = np.random.default_rng(seed), False
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    marked: list[str] = []

    def words(low: int, high: int, stop: str = "") -> str:
        letters = list("abcdefghijklmnoprstuvwéüñ")
        return " ".join("".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(int(rng.integers(low, high + 1)))).capitalize() + stop

    def main(text: str) -> str:
        marked.append(" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", text)).split()))
        return text

    def neutral() -> str:
        return pick("", f"css-{rng.integers(1 << 20):x}", f"{pick('x', 'c', 'sc', 'u', 'el', 'block', 'wrap', 'container', 'row', 'inner')}{rng.integers(100)}")

    def wrapped(tag: str, names: str, inside: str, plain: bool = False) -> str:
        if plain:  # a page whose names say nothing
            names = neutral()
        return f"<{tag}{f' {pick("class", "class", "id")}="{names}"' if names else ''}>{inside}</{tag}>"

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 4)}</a></li>' for k in range(int(rng.integers(low, high + 1)))) + "</ul>"

    def header() -> str:
        return wrapped(pick("header", "header", "div"), pick("header", "masthead", "site header", "top banner", "topbar", "branding"), pick("", f"<p>{words(2, 6)}</p>", f"<h1>{words(1, 3)}</h1><p>{words(3, 8)}</p>") + pick("", links(2, 5)), plain and rng.random() < 0.5)

    def nav() -> str:
        return pick(f"<nav>{links(3, 9)}</nav>", wrapped("div", pick("menu", "nav", "navigation", "breadcrumb", "navbar", "toolbar", "tabs", "site nav", "pagination"), links(3, 9), plain), wrapped("div", neutral(), "".join(f'<a href="/{k}">{words(1, 3)}</a> ' for k in range(4))))

    def notice() -> str:
        return wrapped(pick("div", "section", "p", "aside"), pick("cookie notice", "notice", "alert", "cookie-banner", "consent", "gdpr", "privacy popup", "message bar"), pick("We use cookies to improve this site.", "Please accept cookies.", words(5, 25, ".")))

    def advert() -> str:
        return wrapped(pick("div", "aside", "section"), pick("ad", "ad", "ads", "ad unit", "advert", "advertisement", "sponsored", "promo", "banner ad", "sponsor", "advertising slot"), pick(words(3, 30, "."), f"<p>{words(5, 40, '.')}</p>", f'<a href="/x">{words(3, 9)}</a>'))

    def sidebar() -> str:
        return wrapped(pick("aside", "aside", "div", "section"), pick("sidebar", "related", "widget", "side bar", "recommended", "popular", "share social", "author bio", "see also", "rail", "trending"), f"<h3>{words(1, 4)}</h3>" + pick(links(2, 7), f"<p>{words(6, 40, '.')}</p>"))

    def form() -> str:
        return f"<form{pick('', ' class="newsletter"', ' class="search"', ' id="subscribe"')}><label>{words(1, 4)}</label><input name='q'>{pick('', f'<p>{words(4, 15, ".")}</p>')}<button>{pick('Sign up', 'Search', words(1, 2))}</button></form>"

    def comments() -> str:
        each = lambda: wrapped(pick("div", "li", "article"), pick("comment", "comment body", "reply"), f"<p>{words(1, 3)}</p><p>{words(4, 60, '.')}</p>")
        return wrapped(pick("section", "div", "ol"), pick("comments", "comment list", "discussion comments", "responses comments", "respond"), f"<h2>{words(1, 2)}</h2>" + "".join(each() for _ in range(int(rng.integers(1, 6)))))

    def footer() -> str:
        return wrapped(pick("footer", "footer", "div"), pick("", "footer", "site footer", "copyright"), pick("&copy; ", "© ", "" if not plain else "© ") + words(3, 25, ".") + pick("", links(1, 5), f" &middot; {words(2, 30, '.')}"), plain)

    def body() -> str:
        out = [f"<h1>{main(words(2, 10))}</h1>"] if rng.random() < 0.85 else []
        para = pick("p", "p", "p", "p", "div")
        line = f' class="{neutral()}"' if para == "div" else ""
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.55:
                out.append(f"<p>{main(words(6, 90, '.'))}{pick('</p>', '</p>', '</p>', '')}" if para == "p" else f"<{para}{line}>{main(words(6, 90, '.'))}</{para}>")
            elif kind < 0.75:
                out.append(f"<{para}{line}>{main(words(1, 6, pick('.', '', '|', '***')))}</{para}>")
            elif kind < 0.8:
                out.append(f"<p><b>{main(words(3, 60, '.'))}<br>")
            elif kind < 0.85:
                out.append(f"<h2>{main(words(1, 6))}</h2>")
            elif kind < 0.9:
                out.append(pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{main(words(2, 25, '.'))}</li>" for _ in range(3))))
            elif kind < 0.93:
                out.append(f"<blockquote>{main(words(5, 40, '.'))}</blockquote>")
            elif kind < 0.95:
                cells = "".join(f"<{pick('td', 'td', 'th')}>{main(words(1, 5))}" for _ in range(4))
                out.append(pick("<table><tr>{}</table>", "<table><tbody><tr><td><table><tr>{}</table></table>", "<figure><table><tr>{}</table></figure>").format(cells))
            elif kind < 0.96:
                out.append("<dl>" + "".join(f"<dt>{main(words(1, 3))}<dd>{main(words(3, 20, '.'))}" for _ in range(3)) + "</dl>")
            elif kind < 0.97:
                out.append(pick("<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>").format(main(words(3, 20))))
            else:
                out.append(pick(advert, sidebar, form, notice)())
        return "".join(out)

    pages = []
    for _ in range(n):
        marked.clear()
        plain = bool(rng.random() < 0.35)
        tag, names = pick(("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "entry content"), ("div", "article body"), ("section", "story"), ("div", "post"), ("div", "text"), ("", ""))
        if plain:
            tag, names = pick("div", "div", "section", "td"), neutral()
        parts = [f() for f in (header, nav, notice, advert) if rng.random() < 0.6]
        rng.shuffle(parts)
        inner = body() if rng.random() < 0.95 else ""
        if rng.random() < 0.1:
            inner += comments()
        if tag == "td":  # a table that lays out the page: menus in cells beside the text
            cell = f"<td>{pick(links(3, 8), '')}" + "".join(f'<a href="/{k}">{words(1, 3)}</a><br>' for k in range(3)) + "</td>"
            menu = "<tr>" + "".join(f'<td><a href="/{k}">{words(1, 3)}</a></td>' for k in range(int(rng.integers(2, 7)))) + "</tr>"
            parts.append(f"<table>{pick('', menu)}<tr>{pick('', cell)}<td>{inner}</td></tr></table>")
        else:
            parts.append(wrapped(tag, names, inner) if tag else inner)
        parts += [f() for f in (sidebar, comments, form, advert, footer) if rng.random() < 0.5]
        blocks = blocks_of("<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>")
        wanted, at, labels = list(marked), 0, []
        for b in blocks:
            hit = at < len(wanted) and b.text == wanted[at]
            labels.append(int(hit))
            at += hit
        assert at == len(wanted), "a labelled page's main blocks don't come back"
        pages.append((blocks, labels))
    return pages


def train(pages: list[tuple[list[Block], list[int]]] | None = None) -> Field:
    """Fit on labelled pages (blocks and their labels); on the built-in ones if none are given."""
    field = Field()
    field.fit(labelled_pages() if pages is None else pages)
    return field


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page, field.numbers, field.paths)
    return "\n\n".join(b.text for b, label in zip(blocks, field.decode(blocks), strict=True) if label)


def extract(df: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row, from its whole html.

    A null or empty page, and one in which no block is main text, has the text ''. Repeated rows each get a row, null ids and
    urls stay null, other columns of df are not read, an empty table gives an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 64):
            texts = [main_text(p, own) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
