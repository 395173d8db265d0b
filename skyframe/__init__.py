"""skyframe: clustering statistics on Spark DataFrames.

The engine turns catalogues of weighted points into gridded counts, mode
amplitudes, covariance derivatives, band powers, pair counts and mock
catalogues.  Everything is a DataFrame plan; see README.md for the map of
modules.
"""
