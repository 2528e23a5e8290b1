"""pairloom: budget-aware entity matching analytics written for Spark."""
