"""Column expressions: cells, dates, predicates, aggregates, formulas, masks."""
