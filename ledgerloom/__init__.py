"""ledgerloom: deterministic accounting reconciliation, and operators for text corpora, on Spark DataFrames."""
