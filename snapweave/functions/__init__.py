"""Column expressions; none of them runs a job or a Python worker."""
