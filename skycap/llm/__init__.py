"""Training-data operators: quality rules, deduplication, packing, PII, text
extraction, language identification and byte-pair encoding."""
