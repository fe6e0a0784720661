"""An extension beyond batch use: new archives join a dataset as they arrive."""
