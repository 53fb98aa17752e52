"""DataFrame -> DataFrame operators: pages, cleaning, matching, analytics, exploration."""
