"""DataFrame operators: gridding, matrices, pairs, fields, quadrature, eigenmodes and mocks."""
