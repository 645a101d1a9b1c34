"""Training-data operators: text quality, deduplication, decontamination,
language, toxicity, tokens, chat and URL filters. Nothing else in the library
imports this subpackage."""
