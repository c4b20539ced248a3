"""Graphs have no streams: ownership changes in supersteps, each one shuffle of a batch plan."""
