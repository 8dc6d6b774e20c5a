"""Column expressions. No function here starts a job."""
