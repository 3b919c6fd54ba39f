"""Multi-operator jobs: feature frame, edge set, pairwise experiment."""
