"""Forecasting of one or many series."""
