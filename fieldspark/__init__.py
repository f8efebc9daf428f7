"""fieldspark: DataFrame operators for gridded flow data and trajectories."""
