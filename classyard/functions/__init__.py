from classyard.functions.exprs import *  # noqa: F401,F403
from classyard.functions.hashing import *  # noqa: F401,F403
