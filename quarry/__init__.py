"""quarry: Spark-first analytics over the driver's Parquet tables.

Layout:
    sources/    reading the input tables (pruned, pushdown-friendly scans)
    functions/  Column -> Column expression builders (JVM-side, codegen'd)
    operators/  join / aggregation building blocks with explicit scale policy
    plans/      queries composed from the pieces above
    llm/        operators for training text; nothing else imports them
"""

__version__ = "0.1.0"
