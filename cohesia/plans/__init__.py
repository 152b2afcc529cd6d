"""Multi-operator plans: score tables, sweeps, and the queries of the driver contract."""
