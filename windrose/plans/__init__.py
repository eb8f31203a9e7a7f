"""Registered queries: importing this package's modules fills ``registry.QUERIES``."""
