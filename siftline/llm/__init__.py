"""Training-data operators: quality, filtering, language, licences, deduplication, tokenisation, decontamination, toxicity."""
