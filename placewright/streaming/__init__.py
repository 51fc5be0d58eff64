"""Operators over growing logs."""
