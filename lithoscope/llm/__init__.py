"""Training-data operators: deduplication, decontamination, tokenization, archives, secrets, quality.

Each module holds one operator with its own general interface; ``queries`` derives the digest
columns that the registered queries return.  Nothing outside this subpackage imports it.
"""
