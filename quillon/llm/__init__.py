"""Training-data operators: extraction, language, mixing, quality, licences, BPE, archives, dedup and sharding.

Nothing outside this subpackage imports it; it may be deleted without harm to the SQL engine.
"""
