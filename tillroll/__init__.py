"""tillroll — retail operations analytics as Spark DataFrame operators.

Report ingestion (``sources``), native column expressions (``functions``),
DataFrame -> DataFrame analyses (``operators``), composed report plans and
the query registry (``plans``) and incremental report ingestion
(``streaming``).
"""

__version__ = "0.1.0"
