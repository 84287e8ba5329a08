"""Column expressions: text, dates, numbers, money, ids, names and priority signals."""
