"""Readers of landed records.  Each returns posting columns; new ones are registered by name."""
