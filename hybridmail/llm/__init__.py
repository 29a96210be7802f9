"""Operations of a training-data pipeline. Nothing else in hybridmail imports this subpackage."""
