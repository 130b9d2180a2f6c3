"""DataFrame and SQL operators for corpora that evolve through immutable snapshots."""
