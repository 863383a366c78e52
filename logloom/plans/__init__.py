"""The registered queries: importing the package fills catalogue.QUERIES and catalogue.ORACLES."""

from logloom.plans import catalogue, exceptions, flows, listings, lookups, more, protocols  # noqa: F401
