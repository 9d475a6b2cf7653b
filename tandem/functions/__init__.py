"""Column functions of the operators under one name."""

from tandem.operators.agree import f_score, kappa, mutual_precision, precision, recall
from tandem.operators.retrieve import cosine, dot
from tandem.operators.random import hash_order, hash_uniform
from tandem.operators.scale import abs_tanh, apply_fn, capped_relu, hyperbolic, masked_relu, one_hot, relu, sigmoid, tanh_scaled
from tandem.operators.tokens import strip_sense_number, strip_suffix

__all__ = [
    "abs_tanh", "apply_fn", "capped_relu", "cosine", "dot", "f_score", "hash_order", "hash_uniform", "hyperbolic", "kappa", "masked_relu",
    "mutual_precision", "one_hot", "precision", "recall", "relu", "sigmoid", "strip_sense_number", "strip_suffix", "tanh_scaled",
]
