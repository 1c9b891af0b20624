"""A small relational analytics engine built on PySpark."""
