"""Training-data operators: quality, language, rules, secrets, mixing, chat
snapshots, HTML text, decontamination, similarity join, token files."""
