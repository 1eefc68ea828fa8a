"""Operators for preparing training corpora: filtering, near duplicates, personal data, search, mixing and tokenisation."""
