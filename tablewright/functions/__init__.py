"""Column expressions, name rules and the fixed vocabularies behind them."""
