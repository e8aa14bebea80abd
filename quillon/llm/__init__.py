"""Training-data operators: extraction, packing, chat formatting, deduplication, mixing, token files, quality."""
