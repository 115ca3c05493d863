"""Empty on purpose: the data model has no unbounded input; iteration is batch loops, see plans.loops."""
