"""Relational, windowed, packing, matching and graph operators over DataFrames."""
