"""Column functions: text, paths, hashes and scores."""
