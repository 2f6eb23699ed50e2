"""Training-data operators: mixing, media, packing, chat, nearest neighbours, language, dedup, PII, WARC."""
