"""Operators for preparing training corpora: extraction, deduplication, filtering, scoring, mixing."""
