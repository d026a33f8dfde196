"""Compositions: the bronze-to-marts plan and the registered queries."""
