"""Readers and writers of bars, trades, symbols and configuration."""
