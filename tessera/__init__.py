"""Tessera: data-mining analytics as composable DataFrame operators."""
