"""A PySpark-native engine for vendor price documents: parsing, catalogue search, scoring, quotations and billing."""
