"""The registered queries: known-answer documents, operators over them, and the same results in SQL."""

from . import catalogue

QUERIES, ORACLES, UNSTATED = catalogue.QUERIES, catalogue.ORACLES, catalogue.UNSTATED
