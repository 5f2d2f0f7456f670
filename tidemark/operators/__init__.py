"""Operations that take and return DataFrames."""
