"""End-to-end plans: the correction run and the registered queries."""
