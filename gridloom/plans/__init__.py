"""Named queries over the dataset tables, each with its SQL."""
