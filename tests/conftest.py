import os
import subprocess
import sys
import textwrap

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"

FILES = {
    "shop/cart.py": '''
        """Carts hold what a buyer has picked."""
        from shop.settings import ShopSettings


        class ShoppingCart:
            """A cart of one buyer, priced by the settings of the shop."""

            def __init__(self, settings):
                self.settings = settings
                self.items = []

            def add_item(self, name, price):
                """Puts an item into the cart.

                The price is taken as it is.
                """
                self.items.append((name, price))
                return len(self.items)

            def total(self):
                return sum(price for _, price in self.items) * self.settings.rate()
        ''',
    "shop/settings.py": '''
        """Settings of the shop."""


        class ShopSettings:
            """What prices are multiplied with."""

            tax: float = 0.2
            currency: str = "EUR"

            def rate(self):
                """One and the tax on top of it."""
                return 1 + self.tax
        ''',
    "shop/checkout.py": '''
        """Turns carts into orders."""
        from shop.cart import ShoppingCart
        from shop.settings import ShopSettings


        class Checkout:
            """Sells what is in a cart."""

            def run(self, names):
                """Fills a cart and prices it."""
                cart = ShoppingCart(ShopSettings())
                for name in names:
                    cart.add_item(name, 10)
                if not cart.items:
                    raise RuntimeError("there is nothing in the cart to be sold")
                return cart.total()
        ''',
    "tests/test_cart.py": '''
        from shop.cart import ShoppingCart
        from shop.settings import ShopSettings


        def test_adding_items_to_the_cart():
            cart = ShoppingCart(ShopSettings())
            assert cart.add_item("pen", 2) == 1


        def test_total_of_an_empty_cart():
            assert ShoppingCart(ShopSettings()).total() == 0
        ''',
    "docs/guide.md": """
        # Shop guide

        ## Carts

        A cart holds the items that a buyer has picked. Adding an item to the cart keeps its name and its price, and the total of the cart is their sum with the tax on top.

        ## Checkout

        The checkout fills a cart from a list of names and sells what is in it. An empty cart is an error, as there is nothing in it that could be sold to anyone.
        """,
}


@pytest.fixture(scope="session")
def checkout(tmp_path_factory):
    """A small repository with one commit."""
    root = tmp_path_factory.mktemp("checkout")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(textwrap.dedent(text).lstrip("\n"))
    git = ["git", "-C", str(root), "-c", "user.name=A Writer", "-c", "user.email=a@example.org"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    subprocess.run([*git, "add", "."], check=True)
    subprocess.run([*git, "commit", "-q", "-m", "Add the shopping cart and its checkout", "-m", "Buyers want carts.\nThe tax is on top."], check=True)
    return root
