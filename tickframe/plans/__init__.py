"""Gold tables, reports and monitoring built from the operators."""
