"""Table preparation on Spark: profile, infer roles, check quality, plan, transform, write."""
