"""Factor libraries: daily, minute, order book, futures ticks."""
