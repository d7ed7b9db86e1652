"""Training-data operators. Nothing outside this folder imports it; queries are in ``queries.py``."""
