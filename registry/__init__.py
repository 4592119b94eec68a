"""What the driver runs: queries by operator name, and the SQL each must agree with."""
