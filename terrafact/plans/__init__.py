"""Whole jobs as plans, and the jobs that read and write a warehouse with them."""
