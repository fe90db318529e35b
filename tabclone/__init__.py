"""Structurally faithful synthetic clones of confidential tables, on Spark."""
