"""Plans that need more than one relational step: recursion and the whole analysis."""
