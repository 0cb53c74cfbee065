"""Training-data operators: quality, near-duplicates, archives, personal data, secrets, mixing, decontamination."""
