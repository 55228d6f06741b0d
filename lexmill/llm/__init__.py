"""Training-data operators: language ID, tokenisation, near-duplicate removal, decontamination, archives, chat formatting."""
