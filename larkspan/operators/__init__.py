"""DataFrame operators: detection, evaluation, leakage, text preservation, corpus building, judging."""
