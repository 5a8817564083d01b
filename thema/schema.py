"""Names and schemas shared by all operators.

Long tables: ndw(item_id, pos, class_id, token, weight), dictionary(class_id, token, value, tf, df),
matrix(class_id, token, topic, value), theta(item_id, topic, value), cooc(u, v, value).
"""

from __future__ import annotations

DEFAULT_CLASS = "@default_class"
DEFAULT_TRANSACTION = "@default_transaction"
DOCUMENTS_CLASS = "@documents_class"
#: Values below it count as zero in Phi and Theta.
TINY = 1e-16
#: The default threshold of zero in sparsity scores and sparse exports.
EPS = 1e-37

NDW = "item_id long, title string, pos int, tx_id int, tt_name string, class_id string, token string, weight double"
DICTIONARY = "class_id string, token string, value double, tf double, df double"
MATRIX = "class_id string, token string, topic string, value double"
