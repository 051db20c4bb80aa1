"""Operations on training-data corpora. Nothing else in the package imports this one."""
