"""Nothing here yet: the dialect reads bounded tables only, and has no streaming operators."""
