"""Data-quality checks: each returns findings, one row per thing noticed."""
