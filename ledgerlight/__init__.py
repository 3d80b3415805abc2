"""Ledgerlight: transaction monitoring expressed as Spark plans."""
