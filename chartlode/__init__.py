"""Spark library for longitudinal health records: laboratory results, reports, wearable series, registries and retrieval."""
