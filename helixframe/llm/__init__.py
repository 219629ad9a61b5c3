"""Operations for building training data: filters, searches, mixing and encoding.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
