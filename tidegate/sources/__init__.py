"""Inputs: change logs, the contract catalogue, table descriptions, destinations."""
