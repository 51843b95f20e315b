"""Sources of points. A source is a function that gives a DataFrame with the columns of model.POINT."""
