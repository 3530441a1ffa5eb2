"""Operations of a training-data pipeline, one module per operator; nothing else in the library imports them."""
