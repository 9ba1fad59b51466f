"""Requests, column classes and the plans built from them."""
