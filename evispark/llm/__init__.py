"""Operations of a training-data pipeline over ``documents``; nothing else in the package imports this."""
