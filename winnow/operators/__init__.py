"""DataFrame operators: lazy, side-effect free, DataFrame in and DataFrame out."""
