from coffer.functions import dates, fixed_values, money

__all__ = ["dates", "fixed_values", "money"]
