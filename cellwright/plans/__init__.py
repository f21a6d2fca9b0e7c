"""Whole analyses over the operators. Fields and series that several steps read are written while a plan is built; the rest is lazy."""
