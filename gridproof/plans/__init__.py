"""Registered queries: operators over the driver's tables, each with equivalent SQL."""
