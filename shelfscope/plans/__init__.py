"""Compositions of operators: the stage jobs and the views over the star schema."""
