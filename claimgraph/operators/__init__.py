"""Physical-plan-aware operators over artifact, symbol, evidence and claim tables."""
