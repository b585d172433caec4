"""Operators for preparing training data: token files, shards, near copies, counts, fingerprints, mixing."""
