"""From source files to symbols, references, evidence and claims, as DataFrames."""
