"""Operations of a training-data pipeline on the ``documents`` and
``embeddings`` tables. Nothing else in the library imports this subpackage."""
