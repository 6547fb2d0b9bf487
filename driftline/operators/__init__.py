"""Dataframe operators on time series, events, choices and positions."""
