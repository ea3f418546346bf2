"""Training-data operators: dedup, decontamination, extraction, scans, mixing."""
